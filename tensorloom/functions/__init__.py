"""tensorloom subpackage."""
