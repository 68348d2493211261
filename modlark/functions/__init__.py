"""Part of modlark."""
