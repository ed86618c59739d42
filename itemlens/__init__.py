"""DataFrame operators for "who asks whom about what" data."""
