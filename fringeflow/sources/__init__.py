"""Input tables, derived views, key domains and stored stages."""
