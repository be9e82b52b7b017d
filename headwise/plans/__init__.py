"""End-to-end plans: the test projection, the pipeline and the registered queries."""
