"""DataFrame -> DataFrame operators, from messages to decisions."""
