"""DataFrame operators.  Column names are parameters; domain constants are defaults."""
