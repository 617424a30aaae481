"""Sources: file trees, exclusion lists, mount tables, agent messages."""
