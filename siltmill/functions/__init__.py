"""Part of siltmill."""
