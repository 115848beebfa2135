"""DataFrame -> DataFrame steps of the event and profile pipelines."""
