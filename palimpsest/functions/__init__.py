"""Part of palimpsest; see the modules."""
