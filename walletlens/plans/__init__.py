"""Plans that bundle several operators over one scan, and the recommended session."""
