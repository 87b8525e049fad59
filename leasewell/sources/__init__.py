"""Where queue tables come from and go to."""
