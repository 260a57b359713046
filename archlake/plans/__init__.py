"""Which archives a request, a repair or a proof needs."""
