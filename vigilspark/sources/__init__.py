"""Sources and sinks: the driver tables, journal JSON, flat text logs and
the engine's own state tables (flags, buffer, baseline)."""
