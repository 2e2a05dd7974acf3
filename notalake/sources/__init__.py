"""Where rows come from: files, stores, and fiscal views over relational tables."""
