"""Where results go: tables by tile, catalogues, tracks and debug files."""
