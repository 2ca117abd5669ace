"""Part of the judge-evidence engine."""
