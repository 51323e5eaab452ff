"""Jobs that write: clone of collections, aliases and trees, full backup, delete."""
