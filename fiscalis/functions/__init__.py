"""Part of the library; see the modules."""
