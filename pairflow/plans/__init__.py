"""End-to-end jobs composed of the operators (section 2.13)."""
