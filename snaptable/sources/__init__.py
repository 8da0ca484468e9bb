"""Where rows come from and go to: stored files, catalog, TCP sessions, Spark data source."""
