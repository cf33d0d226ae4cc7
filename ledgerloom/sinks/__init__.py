"""Sinks: versioned publishing, reports, file splits and audit logs."""
