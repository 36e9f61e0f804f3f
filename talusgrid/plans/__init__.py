"""End-to-end plans, the fixture views and the query registry."""
