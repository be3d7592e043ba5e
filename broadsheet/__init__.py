"""Article digest as Spark jobs: feed, pages, links, assets and issue tables."""
