"""Loading drops as they arrive."""
