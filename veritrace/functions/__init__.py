"""veritrace subpackage."""
