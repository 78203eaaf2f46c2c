"""Where data comes from: written intermediate tables and untrusted imports."""
