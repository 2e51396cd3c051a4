"""Jobs made of the operators: the layered batch run and the dashboard document."""
