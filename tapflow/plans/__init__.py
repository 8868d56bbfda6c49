"""End-to-end plans: the registered query catalog, its SQL oracle and the
feature-extraction, clustering and utilisation workflows."""
