"""Planning a scan: splits, header, types."""
