"""Where rows come from and go to: file listings, sidecars, memory records, sectioned CSV, and the views of the test tables."""
