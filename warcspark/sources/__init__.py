"""Reading and writing archive files: framing of bytes, data source, rolling writer."""
