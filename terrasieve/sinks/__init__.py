"""Where results go: growing result tables, manifests, indexes, banks and reports."""
