"""Sources: tables, files and texts as nodes and edges."""
