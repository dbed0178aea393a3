"""Reading and writing: tables of text, CSV, JSON, manifests, Markdown."""
