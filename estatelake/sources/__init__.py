"""Where rows come from and go to: stored tables, pages, dimensions, crawl plans and fixtures."""
