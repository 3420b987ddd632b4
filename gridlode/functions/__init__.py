"""Part of gridlode."""
