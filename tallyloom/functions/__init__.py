"""Part of tallyloom; see the modules."""
