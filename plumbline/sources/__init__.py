"""Where tables come from and results go."""
