"""Reading and writing workbooks."""
