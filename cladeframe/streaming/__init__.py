"""Search traces and scored trees as streams."""
