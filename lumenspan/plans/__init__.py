"""Plans: operators composed into retrieval, linking and evaluation runs, and the query catalogue."""
