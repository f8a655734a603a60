"""Part of folioscope; see README.md."""
