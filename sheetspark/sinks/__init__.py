"""Writers of sheets, payloads and versions."""
