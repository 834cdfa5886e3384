"""Tables: the catalog, and database files."""
