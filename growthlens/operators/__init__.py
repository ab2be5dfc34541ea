"""DataFrame operators for panels. All are lazy unless their docstring names an action."""
