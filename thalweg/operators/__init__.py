"""Part of the profile-segmentation engine."""
