"""Where events, configuration and simulated traffic come from, and where events are kept."""
