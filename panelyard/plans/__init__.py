"""Which moments a fit needs, and the jobs that compute them."""
