"""Sources and sinks of the frame-timeline model."""
