"""lettersift: message triage and mail analytics as Spark DataFrame operators."""
