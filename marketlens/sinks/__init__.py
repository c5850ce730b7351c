"""Where results go: published versions, run logs and log records."""
