"""Sources and sinks: usage CSV landing, warehouse tables, manifest, exports, fixture view."""
