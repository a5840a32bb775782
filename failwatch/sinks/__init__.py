"""Writers for the audit, ML and raw tables."""
