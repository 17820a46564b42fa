"""Part of veritext."""
