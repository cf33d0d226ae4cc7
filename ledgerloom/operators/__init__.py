"""Table-to-table operators. Every one is lazy unless its text says otherwise."""
