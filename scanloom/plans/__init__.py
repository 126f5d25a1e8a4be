"""Named plans over the engine's operators, with SQL that says the same."""
