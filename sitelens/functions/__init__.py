"""Column functions: URLs, text, HTML, robots rules and wordlists."""
