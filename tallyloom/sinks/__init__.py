"""Writers and the check of what was written."""
