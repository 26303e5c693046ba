"""fairground: Spark DataFrame operators for public-event discovery."""
