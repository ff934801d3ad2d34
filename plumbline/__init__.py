"""Pose-keypoint analytics on Spark: cleaning, segmentation, scoring and live detection."""
