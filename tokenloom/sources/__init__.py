"""Where files, patterns and findings come from and go to."""
