"""Named results and the queries registered for checking."""
