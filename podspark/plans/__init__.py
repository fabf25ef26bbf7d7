"""User-level jobs over whole tables."""
