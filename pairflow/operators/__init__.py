"""DataFrame -> DataFrame operators, grouped as in the survey's section 2."""
