"""Named jobs composed from sources and operators."""
