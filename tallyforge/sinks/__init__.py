"""Where results go: rows as JSON Lines, reports as Markdown, vectors by version, logs."""
