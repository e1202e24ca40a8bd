"""Sources: lake inventory, catalog listing, table scans and sampling."""
