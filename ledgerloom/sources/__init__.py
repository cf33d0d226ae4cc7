"""Sources: file manifests, delimited files with per-file semantics, tables and generated rows."""
