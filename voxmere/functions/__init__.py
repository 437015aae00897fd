"""Part of voxmere."""
