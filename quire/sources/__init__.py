"""Where PDF bytes come from and go to."""
