"""Part of newsloom; see README.md."""
