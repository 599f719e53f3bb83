"""Reading and writing record folders."""
