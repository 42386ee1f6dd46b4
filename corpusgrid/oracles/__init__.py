"""Independent SQL, in the dialect of an embedded engine, that queries are held against."""
