"""Part of the docketry engine; see the README."""
