"""DataFrame-to-DataFrame operators; each module covers one stage of the work."""
