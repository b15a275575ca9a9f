"""Column functions: URLs, HTML, time, retry policy."""
