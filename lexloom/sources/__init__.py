"""Files and pages as Markdown documents."""
