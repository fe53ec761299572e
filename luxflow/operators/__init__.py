"""DataFrame operators on events and their side streams."""
