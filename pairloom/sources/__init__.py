"""Line files in and out."""
