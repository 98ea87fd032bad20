"""What sessions are written as."""
